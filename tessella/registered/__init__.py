"""The registered queries, one or more for each operator, with the SQL that must give the same rows."""
