"""Where rows come from and where they go: files, topics, generators."""
