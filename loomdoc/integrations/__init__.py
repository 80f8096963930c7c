"""JSON hooks of web, logging and model frameworks, one module each; a framework is imported with its module alone."""
