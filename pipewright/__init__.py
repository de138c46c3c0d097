"""Sales and support analytics on Spark DataFrames."""

from pipewright.policy import AcceleratePolicy, RenewalPolicy, SlipPolicy
from pipewright.tables import Tables

__all__ = ["AcceleratePolicy", "RenewalPolicy", "SlipPolicy", "Tables"]
