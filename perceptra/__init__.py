"""Range-sensor perception analytics as lazy DataFrame operators."""
