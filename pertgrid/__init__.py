"""Analytics over large sparse measurement tables on PySpark."""
