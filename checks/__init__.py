"""Every operator on the star-schema test tables, each with SQL for comparison."""
