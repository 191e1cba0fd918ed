"""weftwork: analytics and incremental evaluation of task graphs on PySpark."""
