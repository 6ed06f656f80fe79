from .casts import Field
from .integrity import record_hash
from .releases import RELEASE_SHAPE, is_release

__all__ = ["RELEASE_SHAPE", "Field", "is_release", "record_hash"]
