"""Sources and sinks: catalog, CSV sniffing, audit, stores."""
