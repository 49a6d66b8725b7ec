"""Tree construction and proximity joins."""
