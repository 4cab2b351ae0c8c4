from weirflow.plans.flow import Flow, Listener, Recompute
from weirflow.plans.registry import operator, operators, register
from weirflow.plans.rounds import RoundResult, run_rounds

__all__ = ["Flow", "Listener", "Recompute", "RoundResult", "operator", "operators", "register", "run_rounds"]
