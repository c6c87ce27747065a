"""gridloom: numerical, tabular and text operators written as Spark plans."""
