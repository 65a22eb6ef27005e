"""Training-data operators over documents and pages, and the queries that apply them."""
