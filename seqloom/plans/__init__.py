"""Planning decisions made on the driver, and the registered queries."""
