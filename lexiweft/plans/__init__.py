from . import registry, upkeep
