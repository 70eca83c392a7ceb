"""Job settings and the registered queries."""
