"""Where tables live: the catalog and table folders."""
