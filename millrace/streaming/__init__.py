from .updates import Counts, append, append_available, counted, start_counting

__all__ = ["Counts", "append", "append_available", "counted", "start_counting"]
