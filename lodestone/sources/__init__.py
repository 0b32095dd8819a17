"""Where tables live: versioned snapshots, and text and sorted-file sinks."""
