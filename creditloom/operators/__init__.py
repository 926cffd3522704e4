"""DataFrame to DataFrame transforms; none of them writes or reads files."""
