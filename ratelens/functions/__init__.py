"""Column expressions: scalar normalisers and predicates. All run JVM-side
except the label normaliser, which is one Arrow UDF over distinct labels."""
