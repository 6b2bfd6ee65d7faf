"""DataFrame operators; each is ``fn(df, *, keys=..., ...) -> DataFrame`` and lazy."""
