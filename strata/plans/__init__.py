"""Layer tables, ad-hoc and report queries, and the registered query suite."""
