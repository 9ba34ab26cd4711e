"""Object-centric process analytics as Spark jobs.

Business tables become a four-table event log (objects, events, event-to-object
links, skipped rows); everything else in this package is a DataFrame job on it.
"""

from tracewright.plans.log import EventLog
from tracewright.plans.mapping import EventRule, LinkRule, Mapping, ObjectRule
from tracewright.session import get_session

__all__ = ["EventLog", "EventRule", "LinkRule", "Mapping", "ObjectRule", "get_session"]
