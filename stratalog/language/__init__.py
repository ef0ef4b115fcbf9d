"""The surface language: names, syntax tree, macros, declarations, programs and a builder.  Driver side, plain Python."""
