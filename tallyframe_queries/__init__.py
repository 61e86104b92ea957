"""Every operator of ``tallyframe`` as a runnable query with its SQL counterpart."""
