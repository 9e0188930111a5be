"""Names of platform and library functions, which a report mentions but a project doesn't define."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Functions of the C library and its nearest relatives, by header. Longer lists (other platforms, other libraries) are a parameter.
STANDARD = frozenset(
    """
    memcpy memmove memset memcmp memchr memmem bcopy bzero bcmp explicit_bzero
    strcpy strncpy strcat strncat strcmp strncmp strcasecmp strncasecmp strlen strnlen strchr strrchr strstr strspn strcspn strpbrk strtok strtok_r strsep strdup strndup strerror strlcpy strlcat
    malloc calloc realloc reallocarray free alloca aligned_alloc posix_memalign abort exit _exit atexit atoi atol atoll atof strtol strtoul strtoll strtoull strtod getenv setenv qsort bsearch rand srand system
    printf fprintf sprintf snprintf asprintf vprintf vfprintf vsprintf vsnprintf vasprintf dprintf scanf fscanf sscanf fopen fdopen freopen fclose fread fwrite fgets fputs fgetc fputc getc putc puts getline fseek ftell rewind ferror fflush fileno perror popen remove rename
    open openat close read write pread pwrite lseek dup dup2 pipe poll select ioctl fcntl stat fstat lstat chmod mkdir rmdir unlink readlink realpath access isatty
    mmap munmap mprotect brk sbrk fork execve waitpid kill signal sigaction setjmp longjmp getopt getopt_long syscall
    time clock_gettime gettimeofday localtime gmtime mktime strftime sleep usleep nanosleep
    socket bind listen accept connect send sendto recv recvfrom shutdown setsockopt getsockopt getaddrinfo freeaddrinfo htons htonl ntohs ntohl inet_ntop
    isalpha isdigit isspace isupper tolower toupper va_start va_arg va_end wcslen wcscpy
    pthread_create pthread_join pthread_mutex_lock pthread_mutex_unlock dlopen dlsym
    inflate deflate crc32 adler32 SHA256 MD5 HMAC WaitForSingleObject GetProcAddress CloseHandle
    """.split()
)


def is_external(name: Column, further: Iterable[str] = ()) -> Column:
    """Whether a name, as written or without its qualifiers, is a library's; all of namespace std is."""
    bare = F.regexp_replace(name, r"^.*(?:::|\.)", "")
    known = sorted(STANDARD | set(further))
    return name.startswith("std::") | name.isin(known) | bare.isin(known)
