"""What is decided before a plan is built: weights, lanes, and the derived test relations."""
