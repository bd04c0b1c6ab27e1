"""Plan-level building blocks shared by operators: tables, materialisation, hot-key-safe joins."""
