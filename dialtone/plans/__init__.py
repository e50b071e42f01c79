"""Reports and the extract, each a plan over the operators."""
