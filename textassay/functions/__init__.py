"""Column -> Column functions; all but one step of text repair run in the JVM."""
