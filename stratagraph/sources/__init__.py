"""Where rows come from: source trees, profiler files, language-server dumps."""
