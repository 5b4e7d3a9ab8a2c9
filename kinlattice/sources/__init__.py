"""Reading catalogues, tables and arrays, and writing prepared datasets."""
