from skein.functions.vec import Vec3, clamp  # noqa: F401
