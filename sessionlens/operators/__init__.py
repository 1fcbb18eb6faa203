"""DataFrame operators over session events, source trees and dependencies."""
