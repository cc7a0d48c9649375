"""Riskloom: payment-transaction risk scoring as Spark jobs (batch and Structured Streaming)."""
