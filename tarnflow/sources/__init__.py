"""Where relations come from: the interleaved tuple log, graph and social-network preparation, stand-ins on the test tables."""
