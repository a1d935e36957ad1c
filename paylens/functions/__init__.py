"""Expressions shared by the plans, as Spark SQL text.

A text is parsed once on the JVM; the same expression composed from Column
calls takes dozens of round trips, which showed in plan-building time.
"""
