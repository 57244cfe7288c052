"""What can go wrong, as exceptions. All derive from CatalogueError."""


class CatalogueError(Exception):
    """Base of this library's errors."""


class ConfigError(CatalogueError):
    """A rule, policy or argument that can't be used."""


class StoreError(CatalogueError):
    """The catalogue's tables can't be read or written."""


class DriveNotFound(CatalogueError):
    pass


class DriveOffline(CatalogueError):
    pass


class FileMissing(CatalogueError):
    pass


class HashMismatch(CatalogueError):
    pass


class SourceChanged(CatalogueError):
    """A source's hash is not the one that its plan was made for."""


class DestinationVerification(CatalogueError):
    pass


class InsufficientSpace(CatalogueError):
    pass


class InvalidStatusTransition(CatalogueError):
    pass


class InvalidBackend(CatalogueError):
    pass


class MigrationError(CatalogueError):
    pass


class PlanNotFound(CatalogueError):
    pass


class PlanNotApproved(CatalogueError):
    pass


class ExternalToolError(CatalogueError):
    """rsync, rclone or a device tool is missing or failed."""


class InputError(CatalogueError):
    pass
