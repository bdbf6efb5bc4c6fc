"""Views on the driver's tables and the registered queries."""
