"""Column expressions (JVM-side, codegen-friendly) and small numeric helpers."""
