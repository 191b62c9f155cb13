"""The three end-to-end jobs: publish, warehouse, collection."""
