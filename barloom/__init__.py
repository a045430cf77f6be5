"""Bar analytics on Spark: quality checks, features, signals, P&L, selection and streams over fixed-interval bars."""
