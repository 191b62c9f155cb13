"""Writers: idempotent append, verified mirror, published partitions, exports."""
