"""loomwork: a PySpark-native engine for agent-session logs and version-control history."""
