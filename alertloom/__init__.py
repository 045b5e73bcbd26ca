"""Router-syslog analytics as PySpark DataFrame operators."""
