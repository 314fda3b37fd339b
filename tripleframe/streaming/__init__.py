"""The stateless operators on a stream of new generation files."""
