"""Named queries over the test tables, each next to the SQL it must agree with."""
