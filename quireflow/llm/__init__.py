"""Training-data pipeline operators (quality, decontamination, PII, near duplicates, ...).

Nothing else in the library imports this subpackage.
"""
