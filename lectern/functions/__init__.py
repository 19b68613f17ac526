"""Column-level functions (``Column -> Column``), all JVM-side unless noted."""
