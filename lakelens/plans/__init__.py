"""Plans: intent, binding, compilation, cost."""
