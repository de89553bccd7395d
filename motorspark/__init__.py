"""motorspark: Spark jobs for neural and motor-behaviour recordings."""
