"""stepwright: robot-trajectory data work as ordinary Spark DataFrame plans."""
