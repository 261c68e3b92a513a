"""The named queries and the SQL they are checked against."""

from sentrel.plans import knowledge, stored  # noqa: F401  they add their queries and SQL
