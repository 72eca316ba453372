"""Sources: readers and parsers that turn raw texts into fact tables."""
