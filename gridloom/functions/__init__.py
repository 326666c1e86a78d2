"""Value functions: ``values`` for single values, ``columns`` for Spark columns."""
