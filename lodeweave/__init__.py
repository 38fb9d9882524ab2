"""Claim-versus-evidence analytics on PySpark: composable DataFrame operators."""
