"""Output formats: findings and views as documents and lines."""
