"""End-to-end flows, and the registered queries with their SQL counterparts."""
