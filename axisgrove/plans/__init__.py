"""Which strategy a search takes."""
