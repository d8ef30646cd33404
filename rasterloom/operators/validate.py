"""Argument checks shared by the operators."""


def positive_size(*sizes: int) -> None:
    if any(int(s) <= 0 for s in sizes):
        raise ValueError("sizes must be positive")


def odd(k: int, name: str = "kernel size") -> None:
    if k <= 0 or k % 2 == 0:
        raise ValueError(f"{name} must be odd and positive")


def positive(x: float, name: str) -> None:
    if not x > 0:
        raise ValueError(f"{name} must be positive")


def percent(p: float) -> None:
    if not 0 <= p <= 100:
        raise ValueError("percent must lie in 0..100")
