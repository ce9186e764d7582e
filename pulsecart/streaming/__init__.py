"""The operators on unbounded inputs."""
