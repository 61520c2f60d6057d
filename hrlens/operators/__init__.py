"""DataFrame -> DataFrame operators: joins, rates, aggregates, windows, hierarchy,
cleaning, dirtying, validation and profiling."""
