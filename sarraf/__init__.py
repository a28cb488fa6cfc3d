"""A PySpark-native analytics engine for payroll and entitlement lakes."""
