from tidebar.functions.timeframe import TimeFrame

__all__ = ["TimeFrame"]
