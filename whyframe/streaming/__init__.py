"""The parsing steps applied to a stream of questions."""
