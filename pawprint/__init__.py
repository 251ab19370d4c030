"""Pose-trajectory analytics as Spark DataFrame operators."""
