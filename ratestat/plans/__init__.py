"""Query plans: the driver-table profile that stands in for the survey
table, and the reference's questions as compositions of operators."""
