"""Reading and writing the tables of the operators."""
