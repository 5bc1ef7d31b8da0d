"""keyloom: keyed-agent stream analytics on PySpark."""
