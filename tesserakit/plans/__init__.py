"""Named queries over the tables, with SQL equivalents where there are any."""
