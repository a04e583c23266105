"""lakelens: plain-language analytics and data-quality operators over a lake of files, on Spark."""

__version__ = "0.1.0"
