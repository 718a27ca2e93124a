"""Plans: whole jobs that put sources, operators and sinks together."""
