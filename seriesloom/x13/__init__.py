"""Seasonal-adjustment jobs for the program X-13ARIMA-SEATS: specifications, their text, the program's outputs, and runs.

The program itself is not part of this package. Specifications are driver values; runs over a panel happen on the executors.
"""
