"""One Spark function and one SQL text for each operator of the inventory."""
