"""Tables and front ends."""
