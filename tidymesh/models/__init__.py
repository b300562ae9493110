"""Models: functions, bounds and laws, their evaluation and fits."""
