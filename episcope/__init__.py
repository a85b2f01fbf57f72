"""episcope: health-surveillance and cohort analytics as plain Spark DataFrame operators."""
