"""Plan-shaping helpers: durable cuts, skew handling, exact order statistics."""
