"""Column helpers shared by the operators; all of them stay inside Catalyst."""

from fleetscope.functions.ordering import order_key
from fleetscope.functions.scan import let, running_states
from fleetscope.functions.text import after, before, between, contains_lit

__all__ = ["after", "before", "between", "contains_lit", "let", "order_key", "running_states"]
