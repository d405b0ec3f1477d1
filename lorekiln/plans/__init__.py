"""Named queries over the catalog tables, each with its SQL counterpart where SQL can express it."""
