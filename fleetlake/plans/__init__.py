"""Jobs, their schedule, maintenance, and registered queries."""
