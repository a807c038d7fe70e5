"""A document-analytics engine on PySpark: page objects, layout, tables, text, object graphs."""
