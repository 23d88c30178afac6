"""Plans that turn the driver's tables into captures: the inputs of the registered queries."""
